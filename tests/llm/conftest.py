import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

PROSE = " ".join(f"word{i % 37}x{i * i % 101}" for i in range(120))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, root int"

#: Nulls in any column, empty and odd texts, ties, repeated rows and doc_ids, and
#: extra columns whose names clash with those that operators make.
ROWS = [
    (1, PROSE, "en", "a", 1, 5, "k", 1),
    (2, PROSE, "en", "b", 1, 5, "k", 1),
    (3, PROSE + " tail", "en", None, 1, None, None, None),
    (4, "", None, "a", 0, 0, "", 0),
    (5, None, None, None, None, None, None, None),
    (6, "=" * 500, "en", "b", 500, 1, "x", 2),
    (6, "=" * 500, "en", "b", 500, 1, "x", 2),
    (7, "one two", "en", "c", 7, 2, "x", 3),
    (7, "another text under one id " * 9, "en", "c", 7, 2, "x", 3),
    (None, "no id here but words " * 30, "en", "c", 7, 2, "x", 3),
    (None, None, "en", "c", 7, 2, "x", 3),
    (8, "\x00\x1c\x1f \x0b\x0c é ́ 中文 \U0001f600 token = 'Zx9$kQ27vLp' don't", "de", "d", 9, 1, "", 4),
    (9, ("long text with many words and lines\n" * 3000) + "a@b.co", "en", "a", 1, 1, "", 4),
    (10, "ab " * 4000 + "end " + "7" * 3000 + " 1" * 3000 + "a." * 3000, "en", "d", 1, 1, "", 4),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
