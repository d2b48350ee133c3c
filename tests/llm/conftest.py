import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block string, id string, digest string, salt int, bucket int, score string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents, with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "x", "y", "z", 1, 2, "s") for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD = [
    (None, "no id here at all, but with words that repeat words that repeat", None, None),
    (1, None, None, None),
    (2, "", "en", "src1"),
    (3, " \t\n ", None, "src1"),
    (4, "one", "en", None),
    (5, "same text, same text", "en", "src1"),
    (6, "same text, same text", "fr", "src2"),
    (6, "same text, same text", "fr", "src2"),
    (7, "été — 日本語 \U0001f600 naïve", "fr", "src3"),
    (8, "a" * 5000, "en", "src1"),
    (9, "word " * 3000, "en", "src1"),
    (10, "12345 67890 !!!", None, "src4"),
    (12, " ".join(f"w{k * 7919 % 10007}" for k in range(30_000)), "en", "src5"),
    (11, "nul\0inside and <|endoftext|> marks", "en", "src1"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
