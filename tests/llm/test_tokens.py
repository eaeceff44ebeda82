"""Token counts and byte-level BPE against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tabguard.llm import bpe, token_counts

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "é", "日", "　", "\xa0", "😀", "-", "\x00", "the", "ing", "\r\n", "\x1c", "\x85", "▁", "²"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    vocabulary = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def mixed(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(count)]


def test_coder_equals_library(library):
    coder = bpe.Coder(bpe.read_ranks(RANKS), P.PATTERN)
    texts = [*mixed(3000, 1), "a" * 3000, "ab" * 900, " " * 500, "", "e" * 40_000, "the" * 9000]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        assert coder.encode(part) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in part]
    for text, ids in zip(texts, coder.encode(texts)):
        assert coder.decode(ids) == text.encode()


def test_blanks_inside_other_white_space(library):
    coder = bpe.Coder(bpe.read_ranks(RANKS), P.PATTERN)
    rng = random.Random(6)
    texts = ["x \xa0 \xa0 y", "\xa0 \xa0 \xa0", "a\n \nb", "a\n b", "a\t ", " \xa0", " a"]
    texts += [t for _ in range(20_000) if "  " not in (t := "".join(rng.choice(["a", "é1", " ", " ", "\n", "\xa0", "\u3000", "\t", "\x1c", "'s"]) for _ in range(rng.randrange(9))))]
    assert len(texts) > 5000
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_matrix_and_long_path_agree(library):
    coder = bpe.Coder(bpe.read_ranks(RANKS), P.PATTERN)
    for piece in (b"abcabcabcabc", b"theatertheater" * 20, bytes(range(256)) * 3):
        assert coder.encode_pieces([piece])[piece] in (coder.encode_long(piece), coder.rank.get(piece, -1).to_bytes(4, "little", signed=True))


def test_leftmost_of_equal_pairs_first():
    vocabulary = [bytes([i]) for i in range(256)] + [b"aa"]
    coder = bpe.Coder(vocabulary, r"\S+")
    assert np.frombuffer(coder.encode(["aaa"])[0], "<u4").tolist() == [256, 97]


def test_cache_overflow_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED", 10)
    monkeypatch.setattr(bpe, "KEPT", 4)
    coder = bpe.Coder(bpe.read_ranks(RANKS), P.PATTERN)
    for text in mixed(200, 3):
        assert coder.encode([text])[0] == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_round_trip_of_odd_documents(odd_docs, odd_texts, library):
    rows = bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect()
    expected = sorted((str(i), len(e := library.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected


def test_ids_and_decoding(odd_docs, odd_texts, library):
    encoded = bpe.encode_documents(odd_docs, RANKS, P.PATTERN)
    got = sorted((str(r.doc_id), r.ids, r.n_tokens) for r in encoded.collect())
    assert got == sorted((str(i), library.encode_ordinary(t or ""), len(library.encode_ordinary(t or ""))) for i, t in odd_texts)
    decoded = bpe.decode_documents(encoded, RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in decoded) == sorted((str(i), (t or "").encode()) for i, t in odd_texts)


def test_counts_equal_library(pieces):
    with open(MODEL, "rb") as file:
        counts = token_counts.Counts(file.read(), {})
    for text in mixed(5000, 2):
        assert sum(map(counts.__getitem__, token_counts.pre_tokens(text))) == len(pieces.encode(text))


def test_counts_of_odd_documents(odd_docs, odd_texts, pieces):
    rows = token_counts.count_tokens(odd_docs, MODEL, limit=100).collect()
    expected = sorted((str(i), len((t or "").encode()), n := len(pieces.encode(t or "")), n > 100) for i, t in odd_texts)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == expected


def test_empty_tables(no_docs):
    assert bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0
    assert bpe.encode_documents(no_docs, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(no_docs, MODEL).count() == 0


def test_model_that_joins_over_blanks_is_refused():
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(MODEL, "rb") as file:
        model = schema.ModelProto.FromString(file.read())
    model.pieces[1000].piece = "a▁b"
    with pytest.raises(ValueError):
        token_counts.check_model(model.SerializeToString())


def test_two_vocabularies_in_one_session(spark):
    """Workers that live on keep the vocabularies apart, though both start with the single bytes."""
    texts = [(1, "The naïve cat, über 日本語 and the rest of it"), (2, "Se que las ciónes del rey")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        ranks = {t: n for n, t in enumerate(bpe.read_ranks(P.path(name)))}
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        found = {r.doc_id: list(r.ids) for r in bpe.encode_documents(docs, P.path(name), P.PATTERN).collect()}
        assert found == {i: library.encode_ordinary(t) for i, t in texts}


def test_the_first_tier_is_drawn_from_all_partitions(spark):
    """Words of late partitions, and of the middle of long texts, are among the frequent ones."""
    first = [(f"early{i % 50} " * 40,) for i in range(3000)]
    long = [("opening " * 5000 + f"middle{i % 3} " * 60_000,) for i in range(4)]
    late = [(f"late{i % 50} " * 40,) for i in range(3000)]
    docs = spark.createDataFrame(first + long + late, "text string").coalesce(1).repartition(1).select("text")
    with open(P.path("piece_bpe_32k.model"), "rb") as file:
        found = token_counts.frequent_counts(docs, file.read(), "text")
    assert sum(w.startswith("late") for w in found) > 40 and sum(w.startswith("early") for w in found) > 40
    assert token_counts.frequent_counts(docs.where("false"), open(P.path("piece_bpe_32k.model"), "rb").read(), "text") == {}
