import pytest

#: Odd rows that every operator meets: nulls, blanks, ties, repeated rows, a long text, characters of many widths.
ROWS = [
    (1, "The cat sat on the mat, all rights reserved.", "en", "b"),
    (2, "The cat  sat on the mat, all rights\treserved.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\r\n", None, None),
    (6, "über Straße 中文字符 😀😀 naïve café", "de", "a"),
    (6, "über Straße 中文字符 😀😀 naïve café", "de", "a"),
    (7, "word " * 40_000, "en", "b"),
    (8, "cc by cc by general public license cc BY", "en", None),
    (9, "one two", "en", "a"),
    (10, "a" * 3000 + "=" * 500 + "\u0085\u00a0\u2003x", "fr", "z"),
    (11, "The cat sat on the mat, all rights reserved.", "en", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The odd rows, with columns whose names operators use themselves."""
    rows = [(*r, len(r[1] or ""), "x", "y", 5) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, tokens string, kept int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
