"""Sanitisation of personal data, with DataFrame functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. Corpus
co-occurrence then estimates how strongly a term reveals an entity. For entity ``e`` and term ``t``
near it, ``PMI(e; t) = log2(n(e,t) * N / (n(e) * n(t)))`` over documents, against the information
``IC(e) = log2(N / n(e))`` that the entity itself carries. The ratio ``PMI / IC`` is shrunk by
``k / (k + shrink)`` for a pair seen in ``k`` different texts: a single text says nothing, whatever
words it holds. A term whose shrunken ratio is at least ``generalise`` discloses the entity and is generalised to a
placeholder where the entity occurs too; where the ratio itself is at least ``REMOVE`` it is taken out.

Positions in a text come from running sums in blocks of matches, so that the work grows with the text
and its matches, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import query, table
from tabguard.session import write_and_reread

#: The kinds in order, each with a cheap necessary test and its pattern. Possessive
#: quantifiers and starts at the edge of a run find the same matches as plain ones, in linear time.
KINDS = {
    "email": (None, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?:[0-9][ -]?+){12}[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Characters on either side of an entity whose words are its context; texts by which a ratio is
#: shrunk; shares of the entity's information from which a term is generalised or removed.
CONTEXT, SHRINK, GENERALISE, REMOVE = 80, 0.5, 0.8, 0.98
#: Elements of an array that are walked at a time.
BLOCK = 64
#: A letter in place of those of an address while terms are looked for.
COVER = "\u02e2"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column) -> Column:
    """An array that is not empty, cut into arrays of ``BLOCK`` elements."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def _before(numbers: Column, combine) -> Column:
    """For each of ``numbers`` the combination of all before it, 0 for the first: in blocks, then over the blocks."""
    zero = F.lit(0).cast("int")
    none = F.array().cast("array<int>")

    def scan(values, of):
        step = lambda s, x: F.struct(combine(s["at"], of(x)).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))
        return F.aggregate(values, F.struct(zero.alias("at"), none.alias("seen")), step)

    def whole(values):
        inner = F.transform(_blocks(values), lambda block: scan(block, lambda x: x))
        return _bound(inner, lambda blocks: F.flatten(F.zip_with(
            blocks, scan(blocks, lambda x: x["at"])["seen"], lambda block, at: F.transform(block["seen"], lambda x: combine(at, x)))))

    return _bound(numbers, lambda values: F.when(F.size(values) > 0, whole(values)).otherwise(none))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with ``spans`` (start, end, put; sorted) replaced; of overlapping ones the first names what all of them cover."""

    def block_text(block):
        base = block[0]["at"]
        # Of one block's stretch, so that places are counted from its start.
        cut = F.substring(text, base + 1, F.element_at(block, -1)["start"] - base)
        return _bound(cut, lambda part: F.array_join(F.transform(
            block, lambda x: F.concat(F.substring(part, x["at"] - base + 1, x["start"] - x["at"]), x["put"])), ""))

    def whole(values):
        reached = _before(F.transform(values, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        kept = F.filter(F.zip_with(values, reached, lambda x, at: F.struct(x["start"].alias("start"), at.alias("at"), x["put"].alias("put"))), lambda x: x["start"] >= x["at"])
        joined = _bound(kept, lambda found: F.array_join(F.transform(_blocks(found), block_text), ""))
        return F.concat(joined, F.substring(text, F.array_max(F.transform(values, lambda x: x["end"])) + 1, F.length(text)))

    return _bound(spans, lambda values: F.when(F.size(values) > 0, whole(values)).otherwise(text))


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: lengths between and of the matches, summed up."""
    gaps, values = F.call_function("split", text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("n"), v.alias("v")))

    def spans(found):
        def span(pair, at):
            return F.struct(F.lit(kind).alias("kind"), (at + pair["g"]).alias("start"), (at + pair["g"] + pair["n"]).alias("end"), pair["v"].alias("value"))

        return F.zip_with(found, _before(F.transform(found, lambda x: x["g"] + x["n"]), lambda a, b: a + b), span)

    return _bound(pairs, lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.from_json(F.lit("[]"), SPAN)))


def _valid(kind: str):
    return lambda span: _holds(kind, span)


def _holds(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(span["value"], r"\."), lambda p: F.regexp_extract(p, "^0*([0-9]{0,3})$", 1).try_cast("int").between(0, 255) | p.rlike("^0+$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind; a text that fails the cheap test is not searched."""
    none = F.from_json(F.lit("[]"), SPAN)
    out = {}
    for kind, (guard, pattern) in KINDS.items():
        worth = text.contains("@") if guard is None else text.rlike(guard)
        found = F.filter(matches(text, F.lit(pattern), kind), _valid(kind))
        out[kind] = F.when(worth, found).otherwise(none)
    return out


def _with_spans(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` with its spans by kind and all of them, under names of this module's own."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = docs.select("*", F.struct(*(c.alias(k) for k, c in base_spans(text).items())).alias("_pii_base"))
    joined = F.concat(*(F.col(f"_pii_base.{k}") for k in KINDS))
    return found.withColumn("_pii_spans", joined)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _contexts(text: Column, spans: Column) -> Column:
    """(entity, words) of each span: the whole words among the ``CONTEXT`` characters on either side of it."""
    wide = CONTEXT + 1  # one more, to see whether a word is cut
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"))))

    def around(block):
        base = F.greatest(block[0]["start"] - wide, F.lit(0))
        cut = F.substring(text, base + 1, F.array_max(F.transform(block, lambda x: x["end"])) + wide - base)

        def context(part, x):
            before = F.substring(part, F.greatest(x["start"] - wide, F.lit(0)) - base + 1, F.least(x["start"], F.lit(wide)))
            after = F.substring(part, x["end"] - base + 1, F.lit(wide))
            before = F.when(x["start"] > CONTEXT, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
            after = F.when(F.length(after) > CONTEXT, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
            return F.struct(x["entity"].alias("entity"), F.array_union(_words(before), _words(after)).alias("words"))

        return _bound(cut, lambda part: F.transform(block, lambda x: context(part, x)))

    return _bound(ordered, lambda found: F.flatten(F.transform(_blocks(found), around)))


def disclosing_terms(holding: DataFrame, docs: DataFrame, text_column: str = "text", shrink: float = SHRINK, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, ratio, certain) of the terms that disclose an entity: the ratio shrunk and as it is.

    ``holding`` are the rows with spans (``_pii_key``, ``_pii_spans`` and the text), ``docs`` all rows.
    """
    total = docs.count()
    text = F.col(text_column)
    # Rows that hold an entity, with copies; a text counts once for an entity, however often it names it.
    copies = holding.groupBy("_pii_key").agg(F.count(F.lit(1)).alias("copies"))
    near = holding.dropDuplicates(["_pii_key"]).select("_pii_key", F.explode(_contexts(text, F.col("_pii_spans"))).alias("x"))
    near = near.select("_pii_key", "x.entity", F.explode("x.words").alias("term"))
    near = write_and_reread(near.distinct().join(copies, "_pii_key"), "contexts")
    entities = near.select("_pii_key", "entity", "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("n_e"))
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_et"))
    pairs = pairs.withColumn("trust", F.col("texts") / (F.col("texts") + F.lit(shrink))).where(F.col("trust") >= generalise)
    # The ratio can only be reached while n(t) is at most n(e,t) * (N / n(e)) ** (1 - needed): terms that
    # stand near entities in more rows than that are out before the corpus is counted.
    least = near.select("_pii_key", "term", "copies").distinct().groupBy("term").agg(F.sum("copies").alias("at_least"))
    most = F.col("n_et") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1.0) - F.lit(generalise) / F.col("trust"))
    pairs = write_and_reread(pairs.join(entities, "entity").join(least, "term").where(F.col("at_least") <= most * (1 + 1e-9)), "pairs")
    # Rows are numbered before they are exploded: beside an explode in one select, each word would get a number.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), text.cast("string").alias("t"))
    words = numbered.select("row", F.explode(F.split("t", r"[^\p{L}]+")).alias("term"))
    words = words.where(F.col("term") != "").select("row", F.lower("term").alias("term"))
    rows = words.join(pairs.select("term").distinct(), "term", "left_semi").distinct()
    frequency = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = pairs.join(frequency, "term")
    pmi = F.log2(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    carried = F.log2(F.lit(float(total)) / F.col("n_e"))
    certain = F.least(F.when(carried > 0, pmi / carried).otherwise(F.lit(0.0)), F.lit(1.0))
    return scored.select("entity", "term", (certain * F.col("trust")).alias("ratio"), certain.alias("certain")).where(F.col("ratio") >= generalise)


def find_private(docs: DataFrame, text_column: str = "text", shrink: float = SHRINK, generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with ``_pii_base`` (spans by kind), ``_pii_spans`` (all of them, terms last) and ``_pii_removed`` (terms to take out).

    A null text is an empty one. Repeated rows are found each alike; no row is lost, no column read or
    changed but the text. Terms never overlap spans of the base kinds.
    """
    found = _with_spans(docs, text_column)
    text = F.col(text_column).cast("string")
    # The rows that hold an entity are read several times, so they are written.
    holding = write_and_reread(found.where(F.size("_pii_spans") > 0).withColumn("_pii_key", F.sha2(text, 256)), "holding")
    terms = write_and_reread(disclosing_terms(holding, docs, text_column, shrink, generalise), "terms")
    entity = F.explode(F.transform("_pii_spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))).alias("entity")
    # One list for each distinct text that holds an entity; a list holds words of its contexts only.
    listed = holding.select("_pii_key", entity).distinct().join(terms, "entity").groupBy("_pii_key").agg(
        F.sort_array(F.collect_set("term")).alias("_pii_terms"), F.collect_set(F.when(F.col("certain") >= REMOVE, F.col("term"))).alias("_pii_removed"))
    listed = listed.withColumnRenamed("_pii_key", "_pii_listed")
    marked = holding.join(listed, F.col("_pii_key") == F.col("_pii_listed"), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_pii_terms", "|"), F.lit(r")(?!\p{L})"))
    # Terms are letters, and of the base kinds only addresses hold letters: covered, so that no term stands in one.
    covered = _replaced(text, F.transform("_pii_base.email", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["value"], r"\p{L}", COVER).alias("put"))))
    clear = matches(covered, pattern, "term")
    none = F.from_json(F.lit("[]"), SPAN)
    marked = marked.withColumn("_pii_spans", F.concat("_pii_spans", F.when(F.col("_pii_terms").isNotNull(), clear).otherwise(none)))
    marked = marked.withColumn("_pii_removed", F.coalesce("_pii_removed", F.array().cast("array<string>")))
    rest = found.where(F.size("_pii_spans") == 0).withColumn("_pii_removed", F.array().cast("array<string>"))
    return marked.select(*found.columns, "_pii_removed").unionByName(rest)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans, one row for each row of ``docs``."""
    found = find_private(docs.select(id_column, text_column), text_column)
    base = F.concat(*(F.col(f"_pii_base.{k}") for k in KINDS))
    return found.select(id_column, *(F.size(f"_pii_base.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
                        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("_pii_spans")).alias("spans"))


def sanitise(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the spans replaced in the text: entities and disclosing terms by a placeholder, the most telling terms removed.

    Overlapping spans are replaced as one, under the name of the first. Texts without spans, nulls
    included, and all other columns stay as they are.
    """
    found = find_private(docs, text_column)
    text = F.col(text_column)

    def put(span):
        gone = (span["kind"] == "term") & F.array_contains(F.col("_pii_removed"), F.lower(span["value"]))
        return F.when(gone, F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">")))

    ordered = F.array_sort(F.transform("_pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), put(s).alias("put"))))
    clean = _replaced(text, ordered)
    kept = [F.when(F.size("_pii_spans") > 0, clean).otherwise(text).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*kept)


@query()
def op3_private_data(spark, sf_dir):
    return span_report(table(spark, sf_dir, "documents"))
