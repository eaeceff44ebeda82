import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Ids and texts with the cases that every operator must take: null, empty, blanks, long, repeated, odd characters."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, long_text), (6, "plain short text"), (6, "plain short text"), (7, "x" * 40_000),
        (8, "naïve 😀 ÉTÉ 日本語 tail"), (9, "\x00\x01 nul"), (10, "▁ under ▁▁ score"), (None, "a text without an id"), (11, "the end  "),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with other columns, some named like results; ``text`` and ``doc_id`` are read, nothing else may matter."""
    rows = [(i, t, None if n % 2 else "en", f"src{n % 3}", len(t or ""), 1.5, "clash", 7, "k") for n, (i, t) in enumerate(odd_texts)]
    names = "doc_id long, text string, lang string, source string, n_chars int, score double, fingerprint string, n_tokens int, id string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
