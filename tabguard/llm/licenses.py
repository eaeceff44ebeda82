"""License scans: an exact set-similarity join of text blocks with license templates.

The blocks of a template are all stretches of as many words as its own text holds, divided by ``share``: a
block meets the template if it holds at least ``share`` of its distinct words, so that these stand together as a passage.
All words of the templates are ordered by their frequency in the whole corpus, rarest first. A block that meets
a template of ``n`` words needs ``m = ceil(share * n)`` of them, so it holds one of the template's
first ``n - m + 1`` words (prefix filter), it has at least ``m`` words of templates (length filter), and
at the first shared word at least ``m`` words must be left on both sides (positional filter). The filters are
applied to the whole text first, then to the blocks around each prefix word; blocks that pass are verified
by counting, sliding from word to word. Beside that, the base phrases are counted word by word.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import map_texts, query, small_batches, table, words_of

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and licence bodies by label, in plain words; the join compares sets of words.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "this project is licensed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
        "or in connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc": ["this work is licensed under a creative commons attribution license", "licensed under creative commons attribution sharealike 4 0 international"],
    "reserved": ["all rights reserved"],
    "copyright": ["copyright c all rights reserved"],
}
SHARE = 0.9


class Templates:
    """Templates as sets of numbered words, rarest word of the corpus first."""

    def __init__(self, labelled: list[tuple[str, str]], frequency: dict[bytes, int], share: float):
        listed = [(label, words_of(text.encode())) for label, text in labelled]
        listed = [(label, words) for label, words in listed if words]
        order = sorted({w for _, words in listed for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(order)}
        self.labels = [label for label, _ in listed]
        self.words = [sorted({self.number[w] for w in words}) for _, words in listed]
        self.sets = [set(words) for words in self.words]
        self.need = [math.ceil(share * len(words) - 1e-9) for words in self.words]
        self.window = [math.ceil(len(words) / share - 1e-9) for _, words in listed]
        self.prefix = defaultdict(list)
        for t, words in enumerate(self.words):
            for at, word in enumerate(words[: len(words) - self.need[t] + 1]):
                self.prefix[word].append((t, at))

    def candidates(self, held: set[int]):
        """Templates that a text with these words may meet."""
        words, tried = sorted(held), set()
        for at, word in enumerate(words):
            for t, place in self.prefix.get(word, ()):
                if t in tried or len(words) < self.need[t]:
                    continue
                tried.add(t)  # the first shared word: what is shared stands from here on
                if min(len(self.words[t]) - place, len(words) - at) < self.need[t]:
                    continue
                if len(self.sets[t] & held) >= self.need[t]:
                    yield t

    def met(self, places: list[int], numbers: list[int]):
        """(template, share of its words, first word) of every stretch of blocks that meet a template.

        ``places`` and ``numbers`` are where template words stand in a text, and which.
        """
        for t in self.candidates(set(numbers)):
            rare = set(self.words[t][: len(self.words[t]) - self.need[t] + 1])
            reach, low, spans = self.window[t] - 1, 0, []
            for place, number in zip(places, numbers):
                if number in rare:
                    if spans and place - reach <= spans[-1][1]:
                        spans[-1][1] = place + reach
                    else:
                        spans.append([place - reach, place + reach])
            for start, stop in spans:
                low = bisect_left(places, start, low)
                high = bisect_right(places, stop, low)
                yield from self._slide(t, places[low:high], numbers[low:high])

    def _slide(self, t: int, places: list[int], numbers: list[int]):
        wanted, need, window = self.sets[t], self.need[t], self.window[t]
        own = [(p, w) for p, w in zip(places, numbers) if w in wanted]
        if len(own) < need:
            return
        held, left, begun, best, behind = Counter(), 0, None, 0, None
        for place, word in own:
            held[word] += 1
            while own[left][0] <= place - window:
                gone = own[left][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
            if len(held) >= need:
                first = own[left][0]
                if begun is not None and first > behind:  # the next block that meets it stands apart
                    yield t, best / len(wanted), begun
                    begun = None
                if begun is None:
                    begun, best = first, 0
                best, behind = max(best, len(held)), place
        if begun is not None:
            yield t, best / len(wanted), begun


def _phrase_places(words: list[bytes], phrases) -> dict[str, list[int]]:
    out = defaultdict(list)
    for phrase, label in phrases:
        for i in range(len(words) - len(phrase) + 1):
            if words[i + len(phrase) - 1] == phrase[-1] and words[i : i + len(phrase)] == phrase:
                out[label].append(i)
    return out


def word_frequencies(docs: DataFrame, words: set[bytes], text_column: str = "text") -> dict[bytes, int]:
    """In how many rows of ``docs`` each of ``words`` stands; counted within partitions first."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(words.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    # One row for each word of the templates at most.
    return {bytes(r.w): r.n for r in chosen.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = SHARE,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Phrases and templates of every row's whole text.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the phrases; ``labels``
    with those of the templates met too; ``score``, 1 for a phrase, else the largest share of a template
    met, else 0; ``blocks``, the first words of the passages that met a template (blocks that overlap are
    one passage). Null and empty texts have no words. Repeated rows are scanned each; other columns are not read.
    """
    labelled = [(label, text) for label, texts in sorted(templates.items()) for text in texts]
    vocabulary = {w for _, text in labelled for w in words_of(text.encode())}
    index = Templates(labelled, word_frequencies(docs, vocabulary, text_column), share)
    listed = [(words_of(p.encode()), label) for p, label in phrases.items()]
    ends = {words[-1] for words, _ in listed}
    rare = set(index.prefix)

    def one(text: bytes):
        words = words_of(text)
        present = vocabulary.intersection(words)
        places = _phrase_places(words, [x for x in listed if present.issuperset(x[0])]) if not ends.isdisjoint(present) else {}
        found, met_at, best = set(places), [], 1.0 if places else 0.0
        if not rare.isdisjoint(index.number[w] for w in present):
            at = [i for i, w in enumerate(words) if w in present]
            for t, part, first in index.met(at, [index.number[words[i]] for i in at]):
                found.add(index.labels[t])
                met_at.append(first)
                best = max(best, part)
        spots = sorted(i for x in places.values() for i in x)
        return (len(words), len(spots), spots[0] if spots else None, spots[-1] if spots else None,
                ",".join(sorted(places)), ",".join(sorted(found)), best, sorted(set(met_at)))

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]

    def run(texts):
        return [pa.array(column, kind) for column, kind in zip(zip(*map(one, texts)), kinds)] if texts else [pa.array([], k) for k in kinds]

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<long>"
    return map_texts(docs, run, fields, id_column, text_column, as_bytes=True)


@query()
def op1_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
