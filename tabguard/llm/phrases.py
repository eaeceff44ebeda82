"""Phrase collocations by Toivonen mining.

A sample proposes words and pairs that may be frequent. One pass over all texts counts the phrases
that the sample proposes together with their negative border (phrases that are not proposed, but all
of whose parts are): every word, the pairs of two proposed words, the triples of two proposed pairs.
Where a phrase of the border turns out to be frequent, the proposal was too small: it is widened by
what the pass found, and an expansion pass counts the phrases that the wider proposal adds. It counts
the triples of its own border pairs too, whose counts are not known yet, so that one expansion closes
the search: words are known from the first pass, pairs of them from this one. All counts come from passes over all texts, so the result does
not depend on the sample; the sample only decides how many passes there are.

Proposals are held in tables of a fixed number of bits (Bloom filters). A phrase that passes by
chance is counted besides, exactly and once, which costs time and changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm.common import query, small_batches, table
from tabguard.plans.lookups import lookup_join
from tabguard.session import write_and_reread

#: Words that the sample is meant to hold; it sets the number of passes, not the result.
SAMPLE_WORDS = 3_000_000
#: Bits of a table of proposed phrases (2 ** BITS), places a phrase sets.
BITS, PLACES = 25, 3
#: Words that a task counts at a time before it hands its counts on.
WORDS_AT_ONCE = 1 << 20
#: Parts in which the phrases of a language are ranked before its last ranking.
RANK_PARTS = 64

#: ASCII capitals to small letters, ends of pieces to a full stop, tabs to blanks.
_MAP = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x2E if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
_END = b"."


def pieces_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with a full stop (never a word) at every end of a piece."""
    return text.translate(_MAP).replace(_END, b" . ").split(b" ") if text else []


# --- proposals as bit tables ---------------------------------------------------------------------------

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Key of two neighbouring words from the keys of the words."""
    return _mixed(first * _ODD[0] + (second ^ (second >> np.uint64(32))) * _ODD[1] + _ODD[2])


def places(keys: np.ndarray) -> list[np.ndarray]:
    """The bits that stand for each key."""
    step = _mixed(keys * _ODD[1]) | np.uint64(1)
    return [((keys + np.uint64(n) * step) * _ODD[0]) >> np.uint64(64 - BITS) for n in range(1, PLACES + 1)]


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for at in places(keys):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
    return found


def no_proposal() -> np.ndarray:
    return np.zeros(1 << (BITS - 3), dtype=np.uint8)


def word_key(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang) & 0xFFFFFFFF)


def proposal(phrases: DataFrame, words: int) -> np.ndarray:
    """Bit table of the phrases of ``words`` words: set bits are joined in Spark, the table has a fixed size."""
    small_batches(phrases.sparkSession, 10_000)

    def run(batches):
        for batch in batches:
            keys = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lang = lang.encode()
                keys.append([word_key(lang, w) for w in phrase.encode().split(b" ")])
            if keys:
                keys = np.array(keys, dtype=np.uint64)
                keys = keys[:, 0] if words == 1 else pair_key(keys[:, 0], keys[:, 1])
                at = np.unique(np.concatenate(places(keys))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], names=["cell", "bits"])

    cells = phrases.where(F.col("words") == words).select("lang", "phrase").mapInArrow(run, "cell long, bits long")
    found = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 5), dtype=np.uint32)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return bits.view(np.uint8)


# --- a pass over the texts -----------------------------------------------------------------------------


class _Words:
    """Numbers for the words of one language in a stretch of texts, with their keys."""

    def __init__(self, lang: str):
        self.lang, self.seed = lang, xxhash.xxh3_64_intdigest(lang.encode()) & 0xFFFFFFFF
        self.number = {b"": 0, _END: 0}
        self.stream: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        number = self.number  # two places are taken: the numbers of words start at 2
        # Number 0 is the end of a piece; blanks next to each other leave empty words, which are none.
        found = [number.setdefault(w, len(number)) for w in words if w]
        self.stream.append(np.array([*found, 0], dtype=np.int32))


def _count(held: _Words, filters, level: int):
    """Phrases (as arrays of word numbers) that this pass counts, with their counts, for each length."""
    stream = np.concatenate(held.stream)
    names = list(held.number)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w, held.seed) for w in names), np.uint64, len(names))
    old_words, old_pairs, new_words, new_pairs = filters
    real = stream > 0
    if level == 0:
        found = np.bincount(stream, minlength=len(names))
        yield 0, [], np.array([found[1:].sum()]), names
        at = np.flatnonzero(found[1:]) + 1
        yield 1, [at], found[at], names
    two = real[:-1] & real[1:]
    first = np.flatnonzero(two)
    word_new = holds(new_words, keys)
    pairs_in = word_new[stream[first]] & word_new[stream[first + 1]]
    first = first[pairs_in]
    # Distinct pairs of this stretch, and for each place the number of its pair.
    packed = stream[first].astype(np.int64) << 32 | stream[first + 1]
    pairs, which, times = np.unique(packed, return_inverse=True, return_counts=True)
    left, right = pairs >> 32, pairs & 0xFFFFFFFF
    counted = np.ones(len(pairs), dtype=bool)
    if level:
        word_old = holds(old_words, keys)
        counted = ~(word_old[left] & word_old[right])
    yield 2, [left[counted], right[counted]], times[counted], names
    pair_keys = pair_key(keys[left], keys[right])
    pair_new = holds(new_pairs, pair_keys)
    if level:
        pair_new |= counted  # the border of this pass: whatever of it is frequent, its triples are counted
    number = np.full(len(stream) + 1, -1, dtype=np.int64)
    number[first] = which
    start = first[pair_new[which]]
    after = number[start + 1]
    start, after = start[after >= 0], after[after >= 0]
    start, after = start[pair_new[after]], after[pair_new[after]]
    packed = number[start] << 32 | stream[start + 2]
    triples, at, times = np.unique(packed, return_index=True, return_counts=True)
    head, last = triples >> 32, triples & 0xFFFFFFFF
    if level and len(triples):
        # Counted by an earlier pass where both pairs, and so all three words, were proposed then.
        pair_old = holds(old_pairs, pair_keys) & word_old[left] & word_old[right]
        fresh = ~(pair_old[head] & pair_old[after[at]])
        head, last, times = head[fresh], last[fresh], times[fresh]
    yield 3, [left[head], right[head], last], times, names


def count_pass(docs: DataFrame, filters, level: int, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, phrase, words, f): exact counts of the phrases between the old and the new proposal.

    The first pass (``level`` 0) counts every word too, and the words of a language as a phrase of none.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
                         F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("t"))

    def counts(langs):
        for held in langs.values():
            for words, parts, times, names in _count(held, filters, level):
                for start in range(0, len(times), 50_000):
                    chunk = [p[start:start + 50_000].tolist() for p in parts]
                    if words == 0:
                        phrases = [b""]
                    elif words == 1:
                        phrases = [names[a] for a in chunk[0]]
                    elif words == 2:
                        phrases = [names[a] + b" " + names[b] for a, b in zip(*chunk)]
                    else:
                        phrases = [names[a] + b" " + names[b] + b" " + names[c] for a, b, c in zip(*chunk)]
                    n = len(phrases)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([held.lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(n, words, np.int32)),
                         pa.array(times[start:start + n].astype(np.int64))], names=["lang", "phrase", "words", "f"])

    def run(batches):
        langs, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = pieces_of(text)
                if not words:
                    continue
                if lang not in langs:
                    langs[lang] = _Words(lang)
                langs[lang].add(words)
                size += len(words)
                if size >= WORDS_AT_ONCE:
                    yield from counts(langs)
                    langs, size = {}, 0
        yield from counts(langs)

    return chosen.mapInArrow(run, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int, lang_column: str = "lang", text_column: str = "text", sample_words: int = SAMPLE_WORDS) -> tuple[DataFrame, int]:
    """All phrases of one to three words with at least ``least`` places, with exact counts, and the number of passes over the texts.

    A phrase of no words holds the number of all words of its language.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    # A word and its blank take about six bytes.
    share = min(1.0, sample_words * 6 / size) if size else 1.0
    # Lowered, so that few phrases that are frequent in the whole are missed; two places at least, as one says nothing.
    lowered = max(2, int(least * share - 2 * (least * share) ** 0.5)) if share < 1 else least
    nothing = no_proposal()
    everything = ~nothing
    sample = docs.sample(share, seed=1) if share < 1 else docs
    # All words and pairs of the sample: an empty old proposal, every bit set in the new one but no pair, so no triples.
    seen = count_pass(sample, (nothing, nothing, everything, nothing), 0, lang_column, text_column).where((F.col("f") >= lowered) & F.col("words").isin(1, 2))
    seen = write_and_reread(seen, "proposed")
    filters = (nothing, nothing, proposal(seen, 1), proposal(seen, 2))

    def counted(level):
        return write_and_reread(count_pass(docs, filters, level, lang_column, text_column).where((F.col("words") == 0) | (F.col("f") >= least)), "counted")

    found = counted(0)
    often = found.where("words > 0")
    words, pairs = filters[2] | proposal(often, 1), filters[3] | proposal(often, 2)
    if np.array_equal(words, filters[2]) and np.array_equal(pairs, filters[3]):
        return found, 1
    # What is frequent lies outside the proposal: count what the wider proposal adds.
    filters = (filters[2], filters[3], words, pairs)
    return found.unionByName(counted(1)), 2


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two or three words.

    A phrase's score is that of its weakest cut, a * a / (l * r) in millionths, rounded down. Phrases
    that stand inside a longer phrase with at least ``inside`` per cent of their places are dropped. Null texts
    are empty, a null language is ``und``; repeated rows count as often as they stand; languages
    without a phrase have no rows; other columns are ignored. An empty table gives no rows.
    """
    found, _ = frequent_phrases(docs, least, lang_column, text_column)
    total = found.where("words = 0").select("lang", F.col("f").alias("n"))
    often = found.where("words > 0")
    longer = often.where("words = 3").select("lang", "phrase", F.col("f").alias("outer"), F.split("phrase", " ").alias("w"))
    around = (
        longer.select("lang", "outer", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    )
    candidates = often.where("words > 1").join(around, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (F.col("outer") * 100 < F.col("f") * inside)
    )
    w = F.split("phrase", " ")
    cut = F.struct(F.col("k"), F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.lit(3))).alias("tail"))
    cuts = (
        candidates.select("lang", "phrase", F.col("f").alias("a"), "words", w.alias("w"))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    )
    # A common word stands in very many phrases: lookups that spread the rows of such keys.
    counts = often.where("words < 3").select("lang", "phrase", "f")
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = lookup_join(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], None, [name])
    # Decimals of up to 38 digits: products of counts pass 64 bits.
    score = F.expr("cast((1000000 * cast(a as decimal(18,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = (
        weakest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    )
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query(sql=r"""
    WITH texts AS (
        SELECT coalesce(lang, 'und') AS lang,
               string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
        FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM texts)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
    grams AS (
        SELECT lang, 1 AS words, unnest(w) AS phrase FROM words
        UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words)
        UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
    f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY lang, words, phrase HAVING count(*) >= 10),
    cuts AS (
        SELECT lang, words, phrase, f AS a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, words), ' ') AS tail
        FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM f WHERE words > 1)),
    scored AS (
        SELECT c.lang, c.words, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
               CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
    weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
    dropped AS (
        SELECT DISTINCT s.lang, s.phrase FROM f s JOIN (
            SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_phrase
            FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM f WHERE words = 3)) t
        ON t.lang = s.lang AND t.inner_phrase = s.phrase AND 100 * t.f >= 50 * s.f WHERE s.words = 2),
    ranked AS (
        SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, w.l, w.r, n, w.score
        FROM weakest w JOIN totals USING (lang) LEFT JOIN dropped d ON d.lang = w.lang AND d.phrase = w.phrase
        WHERE nth = 1 AND d.phrase IS NULL)
    SELECT * FROM ranked WHERE rank <= 2000
""")
def op13_phrase_mining(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
