import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words string, row long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    line = "the same footer stands under every page of this host"
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, 1, "x", 1), (1, "", "en", "a", 0, 1, "x", 1), (2, " \t\n\x0b\x0c\r ", "en", "a", 7, 2, None, 2)]
    rows += [(3, "word " * 30000, "en", "b", None, None, None, 3), (4, "one two three\none two three\nONE two 3\n\n", "en", None, 1, 1, "1", 4)]
    rows += [(10 + i, " ".join(f"w{i}x{j}" for j in range(30)) + f"\n{line}\n", "en", "c", 1, 1, "1", 5) for i in range(40)]
    rows += [(100 + i, f"{line} {i % 10}\n{line}\n" * 3, "en", "c", 1, 1, "1", 5) for i in range(8)]
    rows += [(200, "é ü　x y\x85z <|endoftext|> a#b*c", "fr", "é", 1, 1, "1", 5), (-5, "x" * 5000, "fr", "z", 1, 1, "1", 5)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
