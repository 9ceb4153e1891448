from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Texts that every operator must take: none, empty, white space only, odd letters and very long ones.
ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "a",
    "Straße ÇA ÉTÉ naïve",
    "x\x1cy\x85z\xa0w",
    "é İ ΑΣ ﬁ 中文 😀",
    "don't <|endoftext|> it's 42!!",
    "word " * 30_000,
    "z" * 100_000,
    "1" * 50_000 + "@" + "a." * 20_000,
]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """The tables are small: two partitions show as much as eight and start fewer tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (doc_id, text) rows, with columns that clash with internal names."""

    def make(rows, **more):
        full = [(i, t, more.get("lang", "en"), "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(2)
        return df.selectExpr("*", "1 as key", "2 as n", "'q' as norm", "3 as `__id`", "4 as text_hash", "5 as row", "6 as term")

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Odd texts, repeated rows, a repeated id with another text and a NULL id."""
    rows = list(enumerate(ODD_TEXTS))
    return docs([*rows, (4, ODD_TEXTS[4]), (3, "another text of three"), (None, "text without id"), (None, "text without id")])


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
