"""The pipeline against its stages done plainly on the driver."""

import hashlib

import public_tokenizers as P
import pytest
from test_simhash import plain_components, plain_print
from test_text_operators import plain_hits, plain_spans

import corpus_pipeline
from tabguard.llm import bpe, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity.op9_toxicity(spark, SMALL).collect()
    held = {r.doc_id: held[r.doc_id] for r in scores if not r.predicted}
    prints = {i: plain_print(t) for i, t in held.items()}
    roots, least = plain_components(set(prints.values())), {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    held = {i: t for i, t in held.items() if least[roots[prints[i]]] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    short = [(i, t) for i, t in held.items() if len(t) < 6000]
    leaks = {int(i) for i, *_ in plain_hits(short, items)}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert leaks.isdisjoint(found) and set(found) <= set(held)
    assert {i for i, _ in short} - leaks <= set(found)
    coder = bpe.Coder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for i, row in found.items():
        text, end, out = held[i], 0, []
        for kind, a, b in sorted(plain_spans(text), key=lambda s: (s[1], s[2], s[0])):
            if a >= end:
                out += [text[end:a], f"<{kind.upper()}>"]
            end = max(end, b)
        clean = "".join([*out, text[end:]])
        assert row.decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()
        assert row.n_tokens == len(coder.encode([clean])[0]) // 4


def test_stages_take_odd_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SMALL)
            rows = out.collect()
            if name != "byte_bpe":
                assert out.columns == docs.columns
            # Texts 4 and 5 are copies; 1, 2 and 3 have no words, one of 6 repeats the other.
            assert len(rows) == (0 if docs is no_docs else docs.count() - 4 if name == "simhash_near_dedup" else docs.count()), name


def test_one_document_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long), (3, long), (3, long), (9, long + " w80"), (7, "something else entirely, in other words"), (None, long)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    kept = corpus_pipeline.simhash_dedup(spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "7", "None"]
