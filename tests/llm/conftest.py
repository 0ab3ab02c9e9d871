import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)

HARD_TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c",
    "a",
    "Über straße   déjà vu \U0001f600\U0001f600",
    "same words here",
    "same  words\there",
    "same words here",
    "<|endoftext|>x<|endoftext|>",
    "\x1c\x1d\x1e\x1f don't   stop",
    "long " * 30_000,
    "x" * 100_000,
    "The quick brown fox jumps over the lazy dog. " * 30,
    "The quick brown fox jumps over the lazy dog. " * 31,
]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text, source) rows; lang and n_chars are null."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def hard_rows():
    """Hard texts with usual ids, then a null id and one row that repeats entirely."""
    rows = [(i * 3, t, [None, "a", "b"][i % 3]) for i, t in enumerate(HARD_TEXTS)]
    return [*rows, (None, "no id at all", "a"), rows[5], rows[5]]
