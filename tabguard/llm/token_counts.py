"""Token counts: a two-tier lookup on the map side, without a shuffle.

The pieces of this model never join characters across a blank that follows text, so the count of a
text is the sum over its pre-tokens (the blanks before a word, and the word). The first tier is a
broadcast table with the counts of frequent pre-tokens; what it lacks is encoded once by the worker
and kept in a cache of bounded size. The table is fitted on a bounded sample of rows; it only saves
time, no count depends on it.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import map_texts, query, table, worker_state

#: Rows and longest text of the sample for the first tier, and pre-tokens in it.
SAMPLE_ROWS, SAMPLE_CHARS, FREQUENT = 1000, 20_000, 32_768
#: Pre-tokens that a worker remembers, and the longest of them; beyond that it starts anew.
CACHED, LONGEST = 400_000, 64
BLANK = "▁"


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first blank, which the library adds itself. Blanks and U+2581 are the same to the model."""
    if not text:
        return []
    if BLANK in text:
        text = text.replace(BLANK, " ")
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]


class Counts(dict):
    """Tokens of a pre-token; a miss asks the library."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self[""] = 1
        self.first = dict(self)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def __missing__(self, word: str) -> int:
        n = len(self.library.encode(word, num_threads=1)) if word else 1
        if len(word) <= LONGEST:
            if len(self) > CACHED + len(self.first):
                self.clear()
                self.update(self.first)
            self[word] = n
        return n


def check_model(model: bytes) -> None:
    """Raise unless pre-tokens of this model are independent of each other."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    spec = schema.ModelProto()
    spec.ParseFromString(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (library.id_to_piece(i) for i in range(library.get_piece_size()))
    plain = spec.normalizer_spec.add_dummy_prefix and spec.normalizer_spec.escape_whitespaces and not (
        spec.normalizer_spec.remove_extra_whitespaces or spec.normalizer_spec.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix)
    if not plain or any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("the model joins characters across blanks or rewrites text: its counts don't add up over words")


def frequent_counts(docs: DataFrame, model: bytes, text_column: str) -> dict[str, int]:
    """The first tier: counts of the most frequent pre-tokens of a bounded sample from all partitions.

    Some ``SAMPLE_ROWS`` rows, at most twice as many, each drawn with the same chance; of a text above
    ``SAMPLE_CHARS`` a stretch of that length from a drawn place. The sample decides what is looked
    up in the first tier, never a count.
    """
    total = docs.count()
    text, room = F.col(text_column).cast("string"), F.lit(SAMPLE_CHARS)
    start = F.when(F.length(text) > room, F.floor(F.rand(2) * (F.length(text) - room)).cast("int")).otherwise(F.lit(0))
    drawn = docs.select(F.substring(text, start + 1, room).alias("t")).where(F.col("t").isNotNull())
    rows = drawn.sample(min(1.0, SAMPLE_ROWS / total), seed=1).limit(2 * SAMPLE_ROWS).collect() if total else []
    seen = Counter(chain.from_iterable(pre_tokens(r.t) for r in rows))
    counts = Counts(model, {})
    return {word: counts[word] for word, _ in seen.most_common(FREQUENT) if len(word) <= LONGEST}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every row's whole text.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each; other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    check_model(model)
    sent = docs.sparkSession.sparkContext.broadcast((model, frequent_counts(docs, model, text_column)))

    def count(texts):
        counts = worker_state(("token_counts", hash(sent.value[0])), lambda: Counts(*sent.value)).__getitem__
        n = [sum(map(counts, pre_tokens(t))) for t in texts]
        return [len(t.encode()) for t in texts], n, [x > limit for x in n]

    return map_texts(docs, count, "n_bytes long, n_tokens long, over_limit boolean", id_column, text_column)


@query()
def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
