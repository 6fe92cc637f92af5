import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
PHRASE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    None, "", "   ", "\n\n", "123 456", "Hello", "two words", "x" * 3000, "a b " * 3000, PHRASE, PHRASE.upper(), PHRASE + " more words follow here",
    "write to bob@mail.example.com or 10.0.0.1 or 300.1.1.1", "card 4316522678525456 and 4316522678525457", "call +1 (743) 555-3824 now or (743) 555-3824",
    "a@b.c+d@e.f 1.2.3.4.5 +12345678 9999", "Ünïcödé   wörds\tand　spaces  twice", "tab\tline\r\nfeed  two", "é" * 500 + " 😀 tail", "| # * % $ < > &",
    PHRASE, PHRASE, "rep rep rep rep rep rep rep rep " * 20, "line one here\nline one here\nother", "<|endoftext|> marks 's it's we'll",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, long and repeated texts, null and repeated keys."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(TEXTS)] + [(3, "again three", "en", "s", 1), (None, "no key", None, None, None), (9, PHRASE, "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
