import os

import pytest

#: Rows that every operator on documents must take: nulls, empty and very long texts, ties, repeated rows.
LONG = "word%d " * 3000 % tuple(range(3000)) + "a" * 60_000
ODD = [
    (1, "The first line is here.\nAnother line of text\n\nthe FIRST line is here.  "), (2, None), (3, ""), (4, "  \t\n "), (5, "The first line is here.\nown words only"), (5, "The first line is here.\nown words only"),
    (None, "The first line is here.\nno id"), (6, LONG), (7, LONG), (8, "<|endoftext|> <|im_end|> it's 12 ünïcode 日本語 🙂 \x1c 　 x  y"), (9, "one two three"), (9, None),
]


@pytest.fixture(scope="session")
def vocabularies():
    return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    rows = [(i, t, n, "k", n, b"x", [n], "f") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece long, keys string, words long, fp binary, ids array<int>, begin string")


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.filter("false")
