import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "two words", "a\tb\x0bc\x0cd\re", "Zeile mit Ärger und ÜBERMUT, zweimal gesagt",
    "İstanbul ß ﬁ é  x y\x85z\x1cq", "漢字 かな 한글 🙂🙂 👩‍👩‍👧 x", "x" * 3000, " " * 500, "1234567890" * 60,
    "it's we'll THEY'RE  <|endoftext|> <|startoftext|> end", "\n".join(["the same long line of text"] * 4),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing and extra columns."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[7], rows[7], (None, "a text without an id but with some words", None, None, None),
             (90, "word " * 30_000 + "end", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {c: F.lit("mine") for c in ("n_lines", "ids", "kept", "spans", "n_words", "host", "score", "extra")}).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet")
